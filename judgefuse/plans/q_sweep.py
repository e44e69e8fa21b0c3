"""Registered queries: threshold and model sweeps and their top-5."""

from __future__ import annotations

import re

from judgefuse.operators import assembly as A
from judgefuse.operators import em as EM
from judgefuse.operators import sweep as SW
from judgefuse.operators.model import RUN_WEIGHTS, ChannelWeights, EMParams
from judgefuse.plans import fixtures as fx
from judgefuse.plans import oracle as O
from judgefuse.plans.registry import register

W = RUN_WEIGHTS
GRID = SW.make_grid([0.6, 0.75, 0.9], [0.2, 0.5, 0.75], [0.5, 0.75], [0.2, 0.6])
# Model parameters that are swept with a refit each: channel weights, verdict weight, temperature.
CONFIGS = {
    "base": EM.EMConfig(max_iter=500, tol=1e-4, weights=RUN_WEIGHTS, temp=0.8),
    "gui": EM.EMConfig(max_iter=500, tol=1e-4, weights=ChannelWeights(1.5, 0.8, 1.0, 0.8), temp=0.8),
    "verdict": EM.EMConfig(max_iter=500, tol=1e-4, weights=ChannelWeights(1.0, 1.0, 0.6, 1.4), temp=1.0),
}
MODEL_GRID = SW.make_grid([0.6, 0.9], [0.5], [0.75], [0.2, 0.6])


def _values(grid):
    return ", ".join(f"({', '.join(map(repr, g))})" for g in grid)


def _rule_sql(grid, source):
    """From ``source`` (split, model, case, env at alpha 1) to the metrics of every grid point."""
    return f""",
grid AS (SELECT * FROM (VALUES {_values(grid)}) AS g(tau_agentfail, tau_envfail, tau_envfail_high, alpha)),
ev AS (
  SELECT c.split, c.model, g.*, c.human_gt, c.agent_original,
    CASE WHEN agent_original = 0 AND 1 - pow(env, alpha) >= g.tau_agentfail THEN 1
         WHEN agent_original = 0 AND pow(env, alpha) >= g.tau_envfail THEN 0
         WHEN agent_original = 1 AND pow(env, alpha) >= g.tau_envfail_high THEN 0
         ELSE CAST(agent_original AS INTEGER) END AS label
  FROM grid g JOIN {source} c ON true WHERE c.human_gt IS NOT NULL),
fl AS (SELECT *, coalesce(agent_original = human_gt, false) AS b, coalesce(label = human_gt, false) AS a,
              NOT coalesce(agent_original = label, false) AS f FROM ev),
agg AS (
  SELECT split, model, tau_agentfail, tau_envfail, tau_envfail_high, alpha, count(*) AS n_cases,
    count(*) FILTER (WHERE b) AS subset_a_total, count(*) FILTER (WHERE b AND f) AS misflip_count,
    count(*) FILTER (WHERE NOT b) AS subset_b_total, count(*) FILTER (WHERE NOT b AND a) AS correction_count,
    count(*) FILTER (WHERE b) / count(*) AS acc_original, count(*) FILTER (WHERE a) / count(*) AS acc_correct
  FROM fl GROUP BY ALL),
res AS (
  SELECT split, model, tau_agentfail, tau_envfail, tau_envfail_high, alpha, n_cases, acc_original, acc_correct,
    subset_a_total, misflip_count,
    CASE WHEN subset_a_total > 0 THEN round(misflip_count / subset_a_total, 4) ELSE 0.0 END AS misflip_rate,
    subset_b_total, correction_count,
    CASE WHEN subset_b_total > 0 THEN round(correction_count / subset_b_total, 4) ELSE 0.0 END AS correction_rate
  FROM agg)"""


SWEEP_SQL = O.with_ctes(O.STEPS_RAW, O.CASE_VALUES, O.posterior_ctes(fx.LIT_PARAMS, W.w, W.agent_weight)) + """,
one AS (
  SELECT 'all' AS split, 'm' AS model, test_case_id, any_value(gt_case) AS human_gt, any_value(c_case) AS agent_original,
         product(1 - least(greatest(p_agent, 0.0), 1.0)) AS env
  FROM step_post GROUP BY test_case_id)""" + _rule_sql(GRID, "one")
_D = ("tau_agentfail", "tau_envfail", "tau_envfail_high", "alpha", "acc_original", "acc_correct", "misflip_rate", "correction_rate")


@register("sweep_thresholds", ops="H17", doubles=_D, sql=SWEEP_SQL + " SELECT * EXCLUDE (split, model) FROM res")
def q_sweep(spark, sf):
    return SW.sweep_thresholds(fx.steps(spark, sf), fx.LIT_PARAMS, W, GRID)


class _Name(str):
    """A column name where the SQL builders expect a number."""
    __repr__ = str.__str__


def _fitted(q):
    return EMParams.two_cause(pi=[_Name(f"{q}.pi0"), _Name(f"{q}.pi1")], theta_env=[_Name(f"{q}.t0{j}") for j in range(3)],
                              theta_agent=[_Name(f"{q}.t1{j}") for j in range(3)], psi=[_Name(f"{q}.psi0"), _Name(f"{q}.psi1")])


def _model_sql():
    base = O.with_ctes(O.STEPS_RAW, O.CASE_VALUES).replace("WITH", "WITH RECURSIVE", 1) + """,
rk AS (SELECT test_case_id, row_number() OVER (ORDER BY md5(concat('42|', test_case_id))) AS r, count(*) OVER () AS n
       FROM (SELECT DISTINCT test_case_id FROM steps)),
part AS (SELECT test_case_id, CASE WHEN r <= floor(n * 0.25) THEN 'val' ELSE 'train' END AS split FROM rk),
cells AS (
  SELECT s.E1_gui, s.E2_code, s.E4_noresp, v.c_case, v.delta_case, sum(s.weight) AS w_sum, count(*) AS n_rows
  FROM steps s JOIN case_vals v USING (test_case_id) JOIN part USING (test_case_id) WHERE split = 'train' GROUP BY ALL)"""
    cases = []
    for k, (name, cfg) in enumerate(CONFIGS.items()):
        w = cfg.weights
        fit = O.em_fit_sql(cfg.max_iter, cfg.tol, w.w, w.agent_weight, cfg.temp)
        fit = re.sub(r"\bem\b", f"em{k}", re.sub(r"\bstop\b", f"stop{k}", fit))
        if k:
            fit = "," + fit[fit.index(f"\nem{k} AS"):]
        l0, l1 = (O.logit_sql(_fitted("q"), d, w.w, True, "c_case", w.agent_weight) for d in range(2))
        base += fit + f""",
post{k} AS (
  SELECT test_case_id, gt_case, c_case, exp(l1 - (mx + ln(exp(l0 - mx) + exp(l1 - mx) + 1e-9))) AS p
  FROM (SELECT *, greatest(l0, l1) AS mx FROM (
    SELECT s.*, v.c_case, v.gt_case, {l0} AS l0, {l1} AS l1
    FROM steps s LEFT JOIN case_vals v USING (test_case_id) JOIN (SELECT * FROM em{k} WHERE it = (SELECT it FROM stop{k})) q ON true)))"""
        cases.append(f"SELECT part.split, '{name}' AS model, test_case_id, any_value(gt_case) AS human_gt, any_value(c_case) AS agent_original, "
                     f"product(1 - least(greatest(p, 0.0), 1.0)) AS env FROM post{k} JOIN part USING (test_case_id) GROUP BY ALL")
    return base + ",\nmany AS (" + " UNION ALL ".join(cases) + ")" + _rule_sql(MODEL_GRID, "many")


MODEL_SQL = _model_sql()


def _models(spark, sf):
    s = A.grouped_split(fx.steps(spark, sf), "test_case_id", 0.25, 42)
    from pyspark.sql import functions as F
    return SW.sweep_models(s, SW.refit(s.filter(F.col("split") == "train"), CONFIGS), MODEL_GRID, "split")


@register("sweep_model", ops="H17", doubles=_D, sql=MODEL_SQL + " SELECT * FROM res")
def q_sweep_model(spark, sf):
    """Each configuration refitted on the training cells; train and validation metrics."""
    return _models(spark, sf)


@register("sweep_top5", ops="F5", doubles=_D, sql=MODEL_SQL + """
SELECT * FROM res WHERE split = 'val'
ORDER BY acc_correct DESC, model, tau_agentfail, tau_envfail, tau_envfail_high, alpha LIMIT 5""")
def q_sweep_top5(spark, sf):
    return SW.top_k(_models(spark, sf).filter("split = 'val'"), 5)

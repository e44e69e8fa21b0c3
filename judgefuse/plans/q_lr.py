"""Registered queries: logistic-regression baseline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from judgefuse.operators import assembly as A
from judgefuse.operators import baseline_lr as LR
from judgefuse.operators import metrics as M
from judgefuse.plans import fixtures as fx
from judgefuse.plans import oracle as O
from judgefuse.plans.jobs import train_lr
from judgefuse.plans.registry import register
from judgefuse.session import shared_folder
from judgefuse.sources.records import write_results

FEAT = LR.FEATURES
# Fixed literal parameters for the SQL-checked scoring and correction queries.
LIT_LR = LR.LRParams(
    coefficients=dict(zip(FEAT, [0.5, -0.3, 0.1, 0.8, 0.2, 0.05, -0.6, -0.2, -0.1, 0.01, 1.2])),
    intercept=0.1,
    scaler_mean=[0.3, 0.5, 1.0, 0.7, 0.7, 2.0, 0.1, 0.2, 0.3, 2.5, 0.5],
    scaler_scale=[0.3, 0.5, 1.0, 0.4, 0.45, 1.5, 0.2, 0.4, 0.5, 1.5, 0.5])

FEAT_SQL = O.with_ctes(O.STEPS_RAW) + """,
cf0 AS (
  SELECT test_case_id,
    avg(E1_gui) AS E1_gui_mean, max(E1_gui) AS E1_gui_max, sum(E1_gui) AS E1_gui_sum,
    avg(E2_code) AS E2_code_mean, max(E2_code) AS E2_code_max, sum(E2_code) AS E2_code_sum,
    avg(E4_noresp) AS E4_noresp_mean, max(E4_noresp) AS E4_noresp_max, sum(E4_noresp) AS E4_noresp_sum,
    CAST(count(*) AS DOUBLE) AS step_count,
    arg_max(agent, ord) FILTER (WHERE agent IS NOT NULL) AS agent_raw,
    arg_max(phi, ord) FILTER (WHERE phi IS NOT NULL) AS label
  FROM steps GROUP BY test_case_id),
cf AS (SELECT test_case_id, """ + ", ".join(
    f"coalesce(CAST({f} AS DOUBLE), 0.0) AS {f}" for f in FEAT if f != "agent_score") + """,
    coalesce(agent_raw, 0.0) AS agent_score, agent_raw, label FROM cf0)"""


@register("case_features", ops="E2", doubles=FEAT + ("agent_raw",), sql=FEAT_SQL + " SELECT * FROM cf")
def q_case_features(spark, sf):
    return LR.case_features(fx.steps(spark, sf))


@register("class_balance", ops="E12", doubles=("class_weight",), sql=FEAT_SQL + """
SELECT label, count(*) AS n_c, (SELECT count(*) FROM cf WHERE label IS NOT NULL) / (2.0 * count(*)) AS class_weight
FROM cf WHERE label IS NOT NULL GROUP BY label""")
def q_class_balance(spark, sf):
    return LR.class_balance(LR.case_features(fx.steps(spark, sf)))


_SC = tuple(f"{f}__{k}" for f in FEAT for k in ("mean", "scale"))


@register("scaler_stats", ops="E13", doubles=_SC, sql=FEAT_SQL + " SELECT " + ", ".join(
    f"avg({f}) AS {f}__mean, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS {f}__scale"
    for f in FEAT) + " FROM cf WHERE label IS NOT NULL")
def q_scaler_stats(spark, sf):
    return LR.scaler_stats(LR.case_features(fx.steps(spark, sf)))


def _z_sql(p):
    terms = [repr(p.intercept)] + [f"{p.coefficients[f]!r} * (({f} - {m!r}) / {s!r})"
                                  for f, m, s in zip(FEAT, p.scaler_mean, p.scaler_scale)]
    return " + ".join(terms)


SCORE_SQL = FEAT_SQL + f""",
sc AS (SELECT test_case_id AS case_id, CAST(label AS INTEGER) AS human_gt,
              CASE WHEN agent_raw IS NOT NULL THEN CAST(CAST(trunc(agent_raw) AS INTEGER) AS DOUBLE) END AS agent_original,
              1.0 - 1.0 / (1.0 + exp(-({_z_sql(LIT_LR)}))) AS P_case_EnvFail,
              1.0 / (1.0 + exp(-({_z_sql(LIT_LR)}))) AS P_case_AgentFail FROM cf)"""
_PD = ("agent_original", "P_case_EnvFail", "P_case_AgentFail")


@register("lr_score", ops="H12", doubles=_PD, sql=SCORE_SQL + " SELECT * FROM sc")
def q_lr_score(spark, sf):
    return LR.score(LR.case_features(fx.steps(spark, sf)), LIT_LR)


_L, _A = O.threshold_rule_sql(0.75, 0.75, 0.75)


@register("lr_correct", ops="H13", doubles=_PD, sql=SCORE_SQL + f" SELECT *, {_L} AS corrected_label, {_A} AS action FROM sc")
def q_lr_correct(spark, sf):
    return LR.correct(LR.score(LR.case_features(fx.steps(spark, sf)), LIT_LR), 0.75, 0.75)


def _fit_on_train(spark, sf):
    s = A.grouped_split(fx.steps(spark, sf), "test_case_id", 0.25, 42)
    train = LR.case_features(s.filter(F.col("split") == "train"))
    return s, train, LR.fit(train)


def newton_sql(C: float = 1.0, rounds: int = 15) -> str:
    """CTEs ``tr`` (train cases), ``st`` (scaling, one row) and ``fit`` (beta): so many Newton rounds
    from zero over the train cases, each a Gauss-Jordan elimination of its 12 x 13 system."""
    k = len(FEAT) + 1
    z = [f"z{i}" for i in range(1, k + 1)]
    stats = ", ".join(f"avg({f}) AS m{i}, CASE WHEN stddev_pop({f}) = 0 THEN 1.0 ELSE stddev_pop({f}) END AS s{i}"
                      for i, f in enumerate(FEAT, 1))
    cols = ", ".join(f"({f} - m{i}) / s{i} AS z{i}" for i, f in enumerate(FEAT, 1))
    dot = " + ".join(f"beta[{i}] * {v}" for i, v in enumerate(z, 1))
    ridge = lambda i, j: "" if i != j or i == k else " + 1.0"
    rows = ", ".join("[" + ", ".join([f"{C!r} * sum(w * p * (1 - p) * {a} * {b}){ridge(i, j)}" for j, b in enumerate(z, 1)]
                                     + [f"{C!r} * sum(w * (p - y) * {a})" + ("" if i == k else f" + beta[{i}]")]) + "]"
                     for i, a in enumerate(z, 1))
    solved = f"SELECT r, beta, [{rows}] AS M FROM (SELECT *, 1.0 / (1.0 + exp(-({dot}))) AS p FROM fit0, zt WHERE r < {rounds}) GROUP BY r, beta"
    for i in range(1, k + 1):
        solved = (f"SELECT r, beta, list_transform(M, lambda line, i: CASE WHEN i = {i} THEN list_transform(line, lambda v: v / line[{i}]) "
                  f"ELSE list_transform(line, lambda v, j: v - line[{i}] * M[{i}][j] / M[{i}][{i}]) END) AS M FROM ({solved})")
    zero = "[" + ", ".join(["0.0::DOUBLE"] * k) + "]"
    return FEAT_SQL.replace("WITH", "WITH RECURSIVE", 1) + f""",
rk AS (SELECT test_case_id, row_number() OVER (ORDER BY md5(concat('42|', test_case_id))) AS r, count(*) OVER () AS n FROM cf),
sp AS (SELECT cf.*, rk.r <= floor(rk.n * 0.25) AS is_val FROM cf JOIN rk USING (test_case_id)),
tr AS (SELECT * FROM sp WHERE NOT is_val AND label IS NOT NULL),
st AS (SELECT {stats} FROM tr),
zt AS MATERIALIZED (
  SELECT {cols}, 1.0 AS z{k}, CAST(label AS DOUBLE) AS y,
         count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)) AS w FROM tr, st),
fit0 AS (
  SELECT 0 AS r, {zero} AS beta
  UNION ALL
  SELECT r + 1, list_transform(beta, lambda b, i: b - M[i][{k + 1}]) FROM ({solved})),
fit AS (SELECT beta FROM fit0 ORDER BY r DESC LIMIT 1)"""


LR_FIT_SQL = newton_sql() + "\n" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, m{i} AS scaler_mean, s{i} AS scaler_scale, beta[{i}] AS coefficient, 0.0 AS residual FROM st, fit"
    for i, f in enumerate(FEAT, 1)) + f" UNION ALL SELECT 'intercept', 0.0, 1.0, beta[{len(FEAT) + 1}], 0.0 FROM fit"


@register("lr_fit", ops="H11", doubles=("scaler_mean", "scaler_scale", "coefficient", "residual"), sql=LR_FIT_SQL)
def q_lr_fit(spark, sf):
    """The fit's scaling and coefficients and, per feature, the gradient there (0 to four places)."""
    _, train, p = _fit_on_train(spark, sf)
    rest = LR.optimality(train, p)
    rows = [(f, float(m), float(sc), p.coefficients[f], round(rest[f], 4) + 0.0)
            for f, m, sc in zip(FEAT, p.scaler_mean, p.scaler_scale)]
    rows.append(("intercept", 0.0, 1.0, p.intercept, round(rest["intercept"], 4) + 0.0))
    return spark.createDataFrame(rows, "feature string, scaler_mean double, scaler_scale double, coefficient double, residual double")


_Z = " + ".join([f"beta[{i}] * (({f} - m{i}) / s{i})" for i, f in enumerate(FEAT, 1)]) + f" + beta[{len(FEAT) + 1}]"
LR_VAL_SQL = newton_sql() + f""",
sc AS (SELECT test_case_id AS case_id, CAST(label AS INTEGER) AS human_gt,
              CASE WHEN agent_raw IS NOT NULL THEN CAST(CAST(trunc(agent_raw) AS INTEGER) AS DOUBLE) END AS agent_original,
              1.0 - 1.0 / (1.0 + exp(-({_Z}))) AS P_case_EnvFail, 1.0 / (1.0 + exp(-({_Z}))) AS P_case_AgentFail
       FROM sp, st, fit WHERE is_val),
corrected AS (SELECT *, {_L} AS corrected_label, {_A} AS action FROM sc),
flags AS (
  SELECT *, coalesce(human_gt = agent_original, false) AS is_correct_before,
         coalesce(human_gt = corrected_label, false) AS is_correct_after,
         NOT coalesce(agent_original = corrected_label, false) AS is_flipped
  FROM corrected)"""


@register("lr_pipeline", ops="H16", doubles=_PD, sql=LR_VAL_SQL + " SELECT * FROM flags")
def q_lr_pipeline(spark, sf):
    """All validation cases, corrected, with their flip flags; those without
    verdict or label are left out of metrics only."""
    s, _, p = _fit_on_train(spark, sf)
    val = LR.case_features(s.filter(F.col("split") == "val"))
    return M.flip_flags(LR.correct(LR.score(val, p), 0.75, 0.75))


@register("lr_job", ops="H16 H12", doubles=("acc_before", "acc_after", "accuracy", "misflip_rate", "correct_rate"), sql=LR_VAL_SQL + """,
v AS (SELECT * FROM flags WHERE agent_original IS NOT NULL AND human_gt IS NOT NULL),
t AS (SELECT count(*) AS n_cases, avg((human_gt = agent_original)::DOUBLE) AS acc_before, avg((human_gt = corrected_label)::DOUBLE) AS acc_after,
             count(*) FILTER (WHERE human_gt = 0 AND corrected_label = 0) AS gt0_pred0,
             count(*) FILTER (WHERE human_gt = 0 AND corrected_label = 1) AS gt0_pred1,
             count(*) FILTER (WHERE human_gt = 1 AND corrected_label = 0) AS gt1_pred0,
             count(*) FILTER (WHERE human_gt = 1 AND corrected_label = 1) AS gt1_pred1,
             avg((human_gt = corrected_label)::DOUBLE) AS accuracy,
             count(*) FILTER (WHERE is_correct_before) AS subset_a,
             count(*) FILTER (WHERE is_correct_before AND is_flipped) AS misflipped,
             count(*) FILTER (WHERE is_correct_before AND agent_original = 0) AS subset_a_orig0,
             count(*) FILTER (WHERE is_correct_before AND is_flipped AND agent_original = 0) AS misflipped_orig0,
             count(*) FILTER (WHERE is_correct_before AND agent_original = 1) AS subset_a_orig1,
             count(*) FILTER (WHERE is_correct_before AND is_flipped AND agent_original = 1) AS misflipped_orig1,
             count(*) FILTER (WHERE NOT is_correct_before) AS subset_b,
             count(*) FILTER (WHERE NOT is_correct_before AND is_correct_after) AS corrected FROM v)
SELECT *, CASE WHEN subset_a > 0 THEN misflipped / subset_a ELSE 0.0 END AS misflip_rate,
       CASE WHEN subset_b > 0 THEN corrected / subset_b ELSE 0.0 END AS correct_rate FROM t""")
def q_lr_job(spark, sf):
    """The job as a user runs it, from a CSV of steps: split, fit, save, validate, sinks; its summary read back."""
    base = f"{shared_folder(spark)}/lr-{uuid.uuid4().hex}"
    write_results(fx.steps_raw(spark, sf), f"{base}/steps.csv", "csv")
    train_lr(spark, f"{base}/steps.csv", f"{base}/out", val_ratio=0.25, seed=42)
    return spark.read.parquet(f"{base}/out/summary")

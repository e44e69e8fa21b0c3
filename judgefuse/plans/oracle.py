"""DuckDB SQL for the fixture views and oracle queries (independent plans).

The oracle deliberately uses a different plan shape from the Spark operators:
case values are joined back row by row, posteriors are computed per step
with CASE expressions, and nothing is folded into aggregation variants.
"""

from __future__ import annotations

import re

from judgefuse.operators.model import EMParams

STEPS_RAW = """
steps_base AS (
  SELECT concat('web_', user_id, '_', day(ts)) AS test_case_id,
         event_id AS ord,
         user_id,
         event_type AS operation_desc,
         CASE WHEN event_type = 'click' THEN (value >= 20)::DOUBLE ELSE 0.0 END AS E1_gui,
         CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS M_gui,
         (((user_id + day(ts)) % 4) <> 0)::DOUBLE AS E2_code,
         0 AS M_code,
         CASE WHEN event_type IN ('error', 'purchase')
              THEN ((CAST(json_extract_string(props, '$.k') AS INTEGER) % 3) = 0)::DOUBLE
              ELSE 0.0 END AS E4_noresp,
         CASE WHEN event_type IN ('error', 'purchase') THEN 0 ELSE 1 END AS M_noresp,
         CASE WHEN event_type IN ('error', 'purchase') THEN 0.5 ELSE 0.3 END AS weight,
         CASE WHEN event_type = 'purchase' THEN 1.0 WHEN event_type = 'error' THEN 0.0
              ELSE NULL END::DOUBLE AS agent_testcase_score,
         CAST((((user_id * 7 + day(ts)) % 10) < 6) AS INTEGER) AS phi
  FROM events),
steps_case_agent AS (
  SELECT test_case_id,
         arg_max(agent_testcase_score, ord) FILTER (WHERE agent_testcase_score IS NOT NULL) AS c
  FROM steps_base GROUP BY test_case_id),
steps AS (
  SELECT b.test_case_id, b.ord, concat(b.test_case_id, '_iter_', b.ord) AS step, b.phi,
         b.operation_desc, b.E1_gui, b.E2_code, b.E4_noresp, b.M_gui, b.M_code, b.M_noresp,
         b.weight, b.agent_testcase_score AS agent,
         CASE WHEN b.user_id % 5 = 0 AND b.phi = 1 AND a.c = 0 THEN 1.0
              WHEN b.user_id % 5 = 0 AND b.phi = 0 AND a.c = 1 THEN 0.0 END::DOUBLE AS delta
  FROM steps_base b LEFT JOIN steps_case_agent a USING (test_case_id))"""

CASE_VALUES = """
case_vals AS (
  SELECT test_case_id,
         arg_max(agent, ord) FILTER (WHERE agent IS NOT NULL) AS c_case,
         arg_max(delta, ord) FILTER (WHERE delta IS NOT NULL) AS delta_case,
         arg_max(phi, ord) FILTER (WHERE phi IS NOT NULL) AS gt_case
  FROM steps GROUP BY test_case_id)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _bern(e: str, p: float) -> str:
    return f"(CASE WHEN {e} = 1 THEN ln({p!r} + 1e-9) ELSE ln(1 - {p!r} + 1e-9) END)"


def evidence_terms_sql(params: EMParams, d: int, weights: list[float] | None,
                       masked: bool) -> list[str]:
    """Per-channel log-likelihood terms of cause d (optionally masked/weighted)."""
    parts = []
    for j, (e, m) in enumerate((("E1_gui", "M_gui"), ("E2_code", "M_code"),
                                ("E4_noresp", "M_noresp"))):
        t = _bern(e, params.theta[d][j])
        if masked:
            t = f"(CASE WHEN {m} = 1 THEN 0.0 ELSE {t} END)"
        if weights is not None:
            t = f"({weights[j]!r} * {t})"
        parts.append(t)
    return parts


def logit_sql(params: EMParams, d: int, weights: list[float] | None, masked: bool,
              agent: str | None, agent_weight: float | None, clip_psi: bool = True) -> str:
    """SQL text of the cause-d log numerator for one step row."""
    parts = [f"ln({params.p_delta[d]!r} + 1e-9)"] + evidence_terms_sql(params, d, weights, masked)
    if agent is not None:
        psi = params.psi[d]
        if clip_psi:
            psi_s = f"least(greatest({psi!r}, 1e-4), 1 - 1e-4)"
            a = (f"(CASE WHEN {agent} IS NULL THEN 0.0 ELSE {agent_weight!r} * "
                 f"({agent} * ln({psi_s}) + (1 - {agent}) * ln(1 - {psi_s})) END)")
        else:
            a = (f"(CASE WHEN {agent} = 1 THEN ln({psi!r} + 1e-9) "
                 f"WHEN {agent} = 0 THEN ln(1 - {psi!r} + 1e-9) ELSE 0.0 END)")
        parts.append(a)
    return " + ".join(parts)


def posterior_ctes(params: EMParams, weights: list[float], agent_weight: float,
                   src: str = "steps") -> str:
    """CTEs step_l (logits) and step_post (P_<cause> and P_agent per step)."""
    ls = ", ".join(f"{logit_sql(params, d, weights, True, 'c_case', agent_weight)} AS l{d}"
                   for d in range(params.k))
    mx = f"greatest({', '.join(f'l{d}' for d in range(params.k))})"
    lse = f"(mx + ln({' + '.join(f'exp(l{d} - mx)' for d in range(params.k))} + 1e-9))"
    ps = ", ".join(f"exp(l{d} - lse) AS p{d}" for d in range(params.k))
    pa = " + ".join(f"exp(l{d} - lse)" for d in range(1, params.k))
    return f"""
step_l AS (
  SELECT s.*, v.c_case, v.gt_case, {ls}
  FROM {src} s LEFT JOIN case_vals v USING (test_case_id)),
step_m AS (SELECT *, {mx} AS mx FROM step_l),
step_n AS (SELECT *, {lse} AS lse FROM step_m),
step_post AS (SELECT *, {ps}, {pa} AS p_agent FROM step_n)"""


def noisy_or_cases_sql(params: EMParams, weights: list[float], agent_weight: float,
                       alpha: float) -> str:
    """CTE ``cases``: E8 case table (no rounding)."""
    return f"""
cases AS (
  SELECT test_case_id AS case_id, any_value(gt_case) AS human_gt,
         any_value(c_case) AS agent_original,
         product(pow(1 - least(greatest(p_agent, 0.0), 1.0), {alpha!r})) AS P_case_EnvFail,
         1 - product(pow(1 - least(greatest(p_agent, 0.0), 1.0), {alpha!r})) AS P_case_AgentFail
  FROM step_post GROUP BY test_case_id)"""


def threshold_rule_sql(ta: float, te: float, teh: float) -> tuple[str, str]:
    label = (f"CASE WHEN agent_original = 0 AND P_case_AgentFail >= {ta!r} THEN 1 "
             f"WHEN agent_original = 0 AND P_case_EnvFail >= {te!r} THEN 0 "
             f"WHEN agent_original = 1 AND P_case_EnvFail >= {teh!r} THEN 0 "
             f"ELSE CAST(agent_original AS INTEGER) END")
    action = (f"CASE WHEN agent_original = 0 AND P_case_AgentFail >= {ta!r} THEN 'flip_to_AgentFail' "
              f"WHEN agent_original = 0 AND P_case_EnvFail >= {te!r} THEN 'keep_EnvFail' "
              f"WHEN agent_original = 1 AND P_case_EnvFail >= {teh!r} THEN 'flip_to_EnvFail' "
              f"ELSE 'keep_AgentJudge' END")
    return label, action


def margin_rule_sql(margin: float, flip_name: str = "'flip_to_AgentFail'") -> tuple[str, str]:
    m = repr(float(margin))
    label = (f"CASE WHEN agent_original IS NULL THEN (CASE WHEN P_case_AgentFail >= P_case_EnvFail THEN 1 ELSE 0 END) "
             f"WHEN agent_original = 0 THEN (CASE WHEN P_case_AgentFail > P_case_EnvFail + {m} THEN 1 ELSE 0 END) "
             f"ELSE (CASE WHEN P_case_EnvFail > P_case_AgentFail + {m} THEN 0 ELSE 1 END) END")
    action = (f"CASE WHEN agent_original IS NULL THEN 'from_model' "
              f"WHEN agent_original = 0 THEN (CASE WHEN P_case_AgentFail > P_case_EnvFail + {m} "
              f"THEN {flip_name} ELSE 'keep_EnvFail_or_AgentFail' END) "
              f"ELSE (CASE WHEN P_case_EnvFail > P_case_AgentFail + {m} THEN 'flip_to_EnvFail' "
              f"ELSE 'keep_AgentJudge' END) END")
    return label, action


def bayes_cases_sql(params: EMParams) -> str:
    """CTE ``bcases``: E9 with unit weights, masks, verdict once, no temperature."""
    sums = ", ".join(
        f"sum({' + '.join(evidence_terms_sql(params, d, None, True))}) AS s{d}"
        for d in range(params.k))
    logits = ", ".join(
        f"ln({params.p_delta[d]!r} + 1e-9) + coalesce(s{d}, 0.0) + "
        f"(CASE WHEN c_case = 1 THEN ln({params.psi[d]!r} + 1e-9) "
        f"WHEN c_case = 0 THEN ln(1 - {params.psi[d]!r} + 1e-9) ELSE 0.0 END) AS l{d}"
        for d in range(params.k))
    mx = f"greatest({', '.join(f'l{d}' for d in range(params.k))})"
    tot = " + ".join(f"exp(l{d} - mx)" for d in range(params.k))
    ps = ", ".join(f"exp(l{d} - mx) / ({tot}) AS P_case_{c}" for d, c in enumerate(params.causes))
    extra = ""
    if params.k > 2:
        extra = ", (" + " + ".join(f"exp(l{d} - mx)" for d in range(1, params.k)) + f") / ({tot}) AS P_case_AgentFail"
    return f"""
b_sum AS (
  SELECT s.test_case_id, any_value(v.c_case) AS c_case, any_value(v.gt_case) AS gt_case, {sums}
  FROM steps s JOIN case_vals v USING (test_case_id) GROUP BY s.test_case_id),
b_l AS (SELECT *, {logits} FROM b_sum),
b_m AS (SELECT *, {mx} AS mx FROM b_l),
bcases AS (
  SELECT test_case_id AS case_id, gt_case AS human_gt, c_case AS agent_original, {ps}{extra}
  FROM b_m)"""


# ---- EM oracle: iterations unrolled as CTEs over the cell table ---------------
EM_CELLS = """
cells AS (
  SELECT s.E1_gui, s.E2_code, s.E4_noresp, v.c_case, v.delta_case,
         sum(s.weight) AS w_sum, count(*) AS n_rows
  FROM steps s JOIN case_vals v USING (test_case_id)
  GROUP BY ALL)"""

_PCOLS = ("pi0", "pi1", "t00", "t01", "t02", "t10", "t11", "t12", "psi0", "psi1")


def em_init_sql() -> str:
    """CTE p0: initial parameters from unweighted channel means."""
    means = [f"sum(n_rows * {e}) / sum(n_rows)" for e in ("E1_gui", "E2_code", "E4_noresp")]
    env = [f"least(greatest({m}, 0.2), 0.8)" for m in means]
    agent = [f"least(greatest({m} + 0.15, 0.2), 0.9)" for m in means]
    return (f"\np0 AS (SELECT 0 AS it, 0.5 AS pi0, 0.5 AS pi1, {env[0]} AS t00, {env[1]} AS t01, "
            f"{env[2]} AS t02, {agent[0]} AS t10, {agent[1]} AS t11, {agent[2]} AS t12, "
            f"0.4 AS psi0, 0.8 AS psi1, CAST('-inf' AS DOUBLE) AS ll FROM cells)")


RESPONSIBILITY = ", ".join(
    f"CASE WHEN delta_case IS NULL THEN exp(l{d} - lden) WHEN delta_case = {d} THEN 1.0 ELSE 0.0 END AS r{d}" for d in (0, 1))
LOG_SUM = "mx + ln(exp(l0 - mx) + exp(l1 - mx) + 1e-9) AS lden"


def em_parts(q: str, w: list[float], aw: float, temp: float, a_pi=5.0, b_pi=5.0, a_c=(3.0, 3.0), b_c=(3.0, 3.0),
             floor=0.05, ceil=0.95, pi_floor=0.02) -> tuple[str, str, str]:
    """Column lists of one EM iteration that reads the parameters of relation
    ``q``: log numerators per cell, weighted sums, new parameters."""
    ls = []
    for d in range(2):
        terms = [f"ln({q}.pi{d} + 1e-9)"]
        for j, e in enumerate(("E1_gui", "E2_code", "E4_noresp")):
            t = f"{q}.t{d}{j}"
            terms.append(f"{w[j]!r} * ({e} * ln({t} + 1e-9) + (1 - {e}) * ln(1 - {t} + 1e-9))")
        ps = f"least(greatest({q}.psi{d}, 1e-4), 1 - 1e-4)"
        terms.append(f"(CASE WHEN c_case IS NULL THEN 0.0 ELSE {aw!r} * (c_case * ln({ps}) + "
                     f"(1 - c_case) * ln(1 - {ps})) END)")
        ls.append(f"({' + '.join(terms)}) / {max(temp, 1e-3)!r} AS l{d}")
    sums = ["sum(w_sum * r0) AS n0", "sum(w_sum * r1) AS n1"]
    for d in range(2):
        for j, e in enumerate(("E1_gui", "E2_code", "E4_noresp")):
            sums.append(f"sum(w_sum * r{d} * {e}) AS o{d}{j}")
        sums.append(f"coalesce(sum(w_sum * r{d}) FILTER (WHERE c_case IS NOT NULL), 0.0) AS den{d}")
        sums.append(f"coalesce(sum(w_sum * r{d} * c_case) FILTER (WHERE c_case IS NOT NULL), 0.0) AS one{d}")
    sums.append("sum(w_sum * lden) / (sum(w_sum) + 1e-9) AS ll")
    new = []
    tot = f"(n0 + n1 + {a_pi + b_pi - 2!r} + 1e-9)"
    for d, a in enumerate((a_pi, b_pi)):
        new.append(f"least(greatest((n{d} + {a - 1!r}) / {tot}, {pi_floor!r}), {1 - pi_floor!r}) AS pi{d}")
    for d in range(2):
        for j in range(3):
            new.append(f"least(greatest(CASE WHEN n{d} <= 0 THEN 0.5 ELSE (o{d}{j} + 0.5) / (n{d} + 1.0 + 1e-9) END, "
                       f"{floor!r}), {ceil!r}) AS t{d}{j}")
    for d in range(2):
        new.append(f"CASE WHEN den{d} > 0 THEN least(greatest((one{d} + {a_c[d] - 1!r}) / "
                   f"(den{d} + {a_c[d] + b_c[d] - 2!r} + 1e-9), 0.02), 0.98) ELSE old_psi{d} END AS psi{d}")
    return ", ".join(ls), ", ".join(sums), ", ".join(new)


def em_iteration(src: str, q: str, carry: str, w: list[float], aw: float, temp: float) -> str:
    """Subquery of one iteration: ``src`` joins the cells with parameters ``q``;
    ``carry`` are columns of q that stay (old_psi0 and old_psi1 among them)."""
    logits, sums, new = em_parts(q, w, aw, temp)
    names = re.sub(r"\S+ AS ", "", carry)
    cells = f"SELECT cells.*, {logits}, {carry} FROM {src}"
    top = f"SELECT *, greatest(l0, l1) AS mx FROM ({cells})"
    den = f"SELECT *, {LOG_SUM} FROM ({top})"
    resp = f"SELECT *, {RESPONSIBILITY} FROM ({den})"
    return f"SELECT {names}, {new}, ll FROM (SELECT {names}, {sums} FROM ({resp}) GROUP BY {names})"


def em_step_sql(w: list[float], aw: float, temp: float) -> str:
    """CTE p1: the parameters after one iteration from p0."""
    carry = "p0.psi0 AS old_psi0, p0.psi1 AS old_psi1"
    return ",\np1 AS (" + em_iteration("cells JOIN p0 ON true", "p0", carry, w, aw, temp) + ")"


def em_fit_sql(max_iter: int, tol: float, w: list[float], aw: float, temp: float) -> str:
    """CTEs p0 and ``em`` (statement starts WITH RECURSIVE): one row per
    iteration until the likelihood moves less than ``tol``."""
    names = [c for c in _PCOLS] + ["ll"]
    first = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in names)
    carry = "q.psi0 AS old_psi0, q.psi1 AS old_psi1, q.it AS old_it, q.ll AS old_ll"
    step = em_iteration(f"cells JOIN em q ON q.going AND q.it < {max_iter}", "q", carry, w, aw, temp)
    return f""",{em_init_sql()},
em AS (
  SELECT 0 AS it, {first}, true AS going FROM p0
  UNION ALL
  SELECT old_it + 1 AS it, {', '.join(names)}, abs(ll - old_ll) >= {tol!r} AS going FROM ({step})),
stop AS (SELECT max(it) AS it FROM em)"""


PARAM_SELECT = ("pi0 AS pi_env, pi1 AS pi_agent, t00 AS theta_env_gui, t01 AS theta_env_code, "
                "t02 AS theta_env_noresp, t10 AS theta_agent_gui, t11 AS theta_agent_code, "
                "t12 AS theta_agent_noresp, psi0 AS psi_env, psi1 AS psi_agent")

"""Registered queries: EM sufficient statistics, init, one step, fit, LL."""

from __future__ import annotations

from judgefuse.operators import em as EM
from judgefuse.operators.model import RUN_WEIGHTS
from judgefuse.plans import fixtures as fx
from judgefuse.plans import oracle as O
from judgefuse.plans.registry import register

W = RUN_WEIGHTS
# Configuration of the reference's command-line training run.
RUN_CFG = EM.EMConfig(max_iter=500, tol=1e-4, weights=W, temp=0.8)
_BASE = [O.STEPS_RAW, O.CASE_VALUES, O.EM_CELLS]
_PD = tuple(EM.PARAM_COLS)


@register("em_cells", doubles=("E1_gui", "E2_code", "E4_noresp", "c_case", "delta_case", "w_sum"),
          ops="E10", sql=O.with_ctes(*_BASE) + " SELECT * FROM cells")
def q_em_cells(spark, sf):
    return EM.em_cells(fx.steps(spark, sf))


@register("em_init", doubles=_PD, ops="H1",
          sql=O.with_ctes(*_BASE, O.em_init_sql()) + f" SELECT {O.PARAM_SELECT} FROM p0")
def q_em_init(spark, sf):
    cells = EM.collect_cells(EM.em_cells(fx.steps(spark, sf)))
    return EM.params_frame(spark, EM.init_params(cells))


@register("em_step", doubles=_PD + ("avg_ll",), ops="H2 H3",
          sql=O.with_ctes(*_BASE, O.em_init_sql()) + O.em_step_sql(W.w, W.agent_weight, RUN_CFG.temp)
          + f" SELECT {O.PARAM_SELECT}, ll AS avg_ll FROM p1")
def q_em_step(spark, sf):
    cells = EM.collect_cells(EM.em_cells(fx.steps(spark, sf)))
    p0 = EM.init_params(cells)
    resp, lden = EM.e_step(p0, cells, RUN_CFG)
    p1 = EM.m_step(p0, resp, cells, RUN_CFG)
    ll = float((cells["w"] * lden).sum() / (cells["w"].sum() + 1e-9))
    return EM.params_frame(spark, p1, {"avg_ll": ll})


EM_FIT_SQL = (O.with_ctes(*_BASE).replace("WITH", "WITH RECURSIVE", 1)
              + O.em_fit_sql(RUN_CFG.max_iter, RUN_CFG.tol, W.w, W.agent_weight, RUN_CFG.temp)
              + f" SELECT {O.PARAM_SELECT}, CAST(it AS BIGINT) AS n_iter FROM em WHERE it = (SELECT it FROM stop)")


@register("em_fit", doubles=_PD, ops="H4", sql=EM_FIT_SQL)
def q_em_fit(spark, sf):
    res = EM.fit(fx.steps(spark, sf), RUN_CFG)
    return EM.params_frame(spark, res.params, {"n_iter": int(res.n_iter)})


_LL = ", ".join(f"{O.logit_sql(fx.LIT_PARAMS, d, W.w, False, 'c_case', W.agent_weight)} AS l{d}" for d in range(2))


@register("em_avg_ll", doubles=("avg_ll",), ops="E11", sql=O.with_ctes(O.STEPS_RAW, O.CASE_VALUES) + f""",
l AS (SELECT s.weight, {_LL} FROM steps s JOIN case_vals v USING (test_case_id)),
m AS (SELECT *, greatest(l0, l1) AS mx FROM l)
SELECT sum(weight * (mx + ln(exp(l0 - mx) + exp(l1 - mx) + 1e-9))) / (sum(weight) + 1e-9) AS avg_ll FROM m""")
def q_em_avg_ll(spark, sf):
    return EM.avg_log_likelihood(fx.steps(spark, sf), fx.LIT_PARAMS, W)

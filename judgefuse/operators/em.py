"""Semi-supervised mixture model fitted by EM on sufficient statistics
(E10, E11, H1-H4, H6).

A step's responsibility in the fit depends only on its binary evidence
pattern, its case's verdict C ∈ {NULL, 0, 1} and its case's label
δ ∈ {NULL, 0, 1}; all parameter updates are weighted sums of
responsibilities.  So one Spark aggregation into (pattern, C, δ) cells —
at most 2^3·3·3 = 72 rows, a bound fixed by the domains, not the data —
carries everything the iterations need.  Spark reads all the data once; the
iterations run over that tiny table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgefuse.operators.model import EPS, ChannelWeights, EMParams, softmax_eps, step_base_logits
from judgefuse.operators.steps import last_non_null

E_COLS = ("E1_gui", "E2_code", "E4_noresp")
M_COLS = ("M_gui", "M_code", "M_noresp")


@dataclass
class EMConfig:
    """Hyper-parameters of the fit (defaults as in the reference's class)."""

    max_iter: int = 100
    tol: float = 1e-4
    weights: ChannelWeights = field(default_factory=ChannelWeights)
    a_pi: float = 5.0
    b_pi: float = 5.0
    a_c0: float = 3.0
    b_c0: float = 3.0
    a_c1: float = 3.0
    b_c1: float = 3.0
    theta_floor: float = 0.05
    theta_ceil: float = 0.95
    pi_floor: float = 0.02
    temp: float = 0.8
    mask_in_fit: bool = False  # parity: the reference's fit ignores masks (Q4)


@dataclass
class EMResult:
    params: EMParams
    n_iter: int
    avg_ll: float
    ll_trace: list[float]


def em_cells(steps: DataFrame, mask_in_fit: bool = False) -> DataFrame:
    """Σ weight and row count per (evidence pattern, case C, case δ) cell.

    Two aggregations, no join: first per case (verdict and label are
    last-non-null values; pattern weights/counts are pivoted into columns),
    then per (C, δ, pattern).  Both combine map-side, so a case that holds a
    third of all rows adds one partial row per map task, not a hot task.
    """
    bits = list(E_COLS) + (list(M_COLS) if mask_in_fit else [])
    n_pat = 1 << len(bits)
    pat = sum((F.col(b).cast("int") * F.lit(1 << (len(bits) - 1 - i)) for i, b in enumerate(bits)),
              F.lit(0))
    s = steps.withColumn("_pat", pat)
    per_case = s.groupBy("test_case_id").agg(
        last_non_null("agent").alias("c_case"),
        last_non_null("delta").alias("delta_case"),
        *[F.sum(F.when(F.col("_pat") == p, F.col("weight"))).alias(f"_w{p}") for p in range(n_pat)],
        *[F.count_if(F.col("_pat") == p).alias(f"_n{p}") for p in range(n_pat)])
    cells = per_case.select(
        "c_case", "delta_case",
        F.explode(F.array(*[F.struct(F.lit(p).alias("pat"), F.coalesce(F.col(f"_w{p}"), F.lit(0.0)).alias("w"),
                                     F.col(f"_n{p}").alias("n")) for p in range(n_pat)])).alias("x")
    ).where(F.col("x.n") > 0)
    out = cells.groupBy("c_case", "delta_case", F.col("x.pat").alias("pat")).agg(
        F.sum("x.w").alias("w_sum"), F.sum("x.n").alias("n_rows"))
    return out.select(
        *[((F.col("pat").bitwiseAND(F.lit(1 << (len(bits) - 1 - i))) > 0).cast("int")
           .cast("double" if b.startswith("E") else "int")).alias(b) for i, b in enumerate(bits)],
        "c_case", "delta_case", "w_sum", "n_rows")


def collect_cells(cells: DataFrame, mask_in_fit: bool = False) -> dict[str, np.ndarray]:
    """Bring the cell table to the driver (≤ 72 rows, ≤ 576 with masks)."""
    rows = cells.collect()
    limit = 576 if mask_in_fit else 72
    if len(rows) > limit:
        raise ValueError(f"cell table has {len(rows)} rows, expected at most {limit}")
    nan = float("nan")
    e = np.array([[r[c] for c in E_COLS] for r in rows], float).reshape(-1, 3)
    m = (np.array([[r[c] for c in M_COLS] for r in rows], float).reshape(-1, 3)
         if mask_in_fit else np.zeros_like(e))
    c = np.array([nan if r["c_case"] is None else r["c_case"] for r in rows], float)
    d = np.array([nan if r["delta_case"] is None else r["delta_case"] for r in rows], float)
    w = np.array([r["w_sum"] for r in rows], float)
    n = np.array([r["n_rows"] for r in rows], float)
    return {"e": e, "m": m, "c": c, "d": d, "w": w, "n": n}


def init_params(cells: dict[str, np.ndarray]) -> EMParams:
    """H1: π = (.5,.5); θ from the unweighted channel means; ψ = (.4,.8)."""
    n = cells["n"]
    mean = (cells["e"] * n[:, None]).sum(axis=0) / n.sum() if n.sum() > 0 else np.zeros(3)
    return EMParams(["EnvFail", "AgentFail"], [0.5, 0.5],
                    [list(np.clip(mean, 0.2, 0.8)), list(np.clip(mean + 0.15, 0.2, 0.9))],
                    [0.4, 0.8])


def _log_num(p: EMParams, cells, cfg: EMConfig, temp: float | None) -> np.ndarray:
    e, m, c = cells["e"], cells["m"], cells["c"]
    w = np.array(cfg.weights.w)
    out = np.zeros((len(e), p.k))
    for d in range(p.k):
        th = np.array(p.theta[d])
        ll = e * np.log(th + EPS) + (1 - e) * np.log(1 - th + EPS)
        if cfg.mask_in_fit:
            ll = np.where(m == 1, 0.0, ll)
        base = (ll * w).sum(axis=1)
        psi = min(max(p.psi[d], 1e-4), 1 - 1e-4)
        has_c = ~np.isnan(c)
        cc = np.where(has_c, c, 0.0)
        agent = np.where(has_c, cfg.weights.agent_weight * (cc * math.log(psi) + (1 - cc) * math.log(1 - psi)), 0.0)
        out[:, d] = math.log(p.p_delta[d] + EPS) + base + agent
    if temp is not None:
        out = out / temp
    return out


def e_step(p: EMParams, cells, cfg: EMConfig) -> tuple[np.ndarray, np.ndarray]:
    """H2: tempered responsibilities per cell (labelled cells clamped) and log Z."""
    ln = _log_num(p, cells, cfg, max(cfg.temp, 1e-3))
    mx = ln.max(axis=1, keepdims=True)
    lden = mx + np.log(np.exp(ln - mx).sum(axis=1, keepdims=True) + EPS)
    resp = np.exp(ln - lden)
    d = cells["d"]
    lab = ~np.isnan(d)
    if lab.any():
        resp[lab] = 0.0
        resp[lab, d[lab].astype(int)] = 1.0
    return resp, lden[:, 0]


def m_step(p: EMParams, resp: np.ndarray, cells, cfg: EMConfig) -> EMParams:
    """H3: Beta-MAP π with floor, pseudo-count θ with clip, Beta-MAP ψ on cases with C."""
    w, e, c = cells["w"], cells["e"], cells["c"]
    nk = (w[:, None] * resp).sum(axis=0)
    pi = (nk + np.array([cfg.a_pi - 1, cfg.b_pi - 1])) / (nk.sum() + cfg.a_pi + cfg.b_pi - 2 + EPS)
    pi = np.clip(pi, cfg.pi_floor, 1.0 - cfg.pi_floor)
    theta = [list(r) for r in p.theta]
    for d in range(2):
        wk = w * resp[:, d]
        den = wk.sum()
        for j in range(3):
            val = 0.5 if den <= 0 else (float((wk * e[:, j]).sum()) + 0.5) / (den + 1.0 + EPS)
            theta[d][j] = float(np.clip(val, cfg.theta_floor, cfg.theta_ceil))
    psi = list(p.psi)
    has_c = ~np.isnan(c)
    cc = np.where(has_c, c, 0.0)
    for d, (a, b) in enumerate(((cfg.a_c0, cfg.b_c0), (cfg.a_c1, cfg.b_c1))):
        r = w * resp[:, d]
        den = float(r[has_c].sum())
        ones = float((r * cc)[has_c].sum())
        if den > 0:
            psi[d] = float(np.clip((ones + a - 1) / (den + a + b - 2 + EPS), 0.02, 0.98))
    return EMParams(p.causes, [float(x) for x in pi], theta, psi)


def fit_cells(cells, cfg: EMConfig) -> EMResult:
    """H4: iterate H2/H3 until |ΔLL| < tol or max_iter, over the cell table."""
    p = init_params(cells)
    prev = -np.inf
    trace = []
    it = 0
    w = cells["w"]
    for it in range(1, cfg.max_iter + 1):
        resp, lden = e_step(p, cells, cfg)
        p = m_step(p, resp, cells, cfg)
        ll = float((w * lden).sum() / (w.sum() + EPS))
        trace.append(ll)
        if abs(ll - prev) < cfg.tol:
            break
        prev = ll
    return EMResult(p, it, trace[-1] if trace else float("nan"), trace)


def fit(steps: DataFrame, cfg: EMConfig = EMConfig()) -> EMResult:
    """H4 end to end: one Spark aggregation, then iterations on ≤ 72 cells."""
    return fit_cells(collect_cells(em_cells(steps, cfg.mask_in_fit), cfg.mask_in_fit), cfg)


def avg_log_likelihood(steps: DataFrame, params: EMParams,
                       weights: ChannelWeights = ChannelWeights()) -> DataFrame:
    """Σ w·log Z / Σ w with the given params, untempered, masks not
    applied, verdict channel from each case's last verdict (``_score_avg_ll``).

    Computed from the cell table (same sums, far fewer rows to evaluate).
    """
    cells = em_cells(steps, False)
    base = step_base_logits(params, weights.w, [F.col(c) for c in E_COLS], None)
    logits = []
    for d in range(params.k):
        psi = min(max(params.psi[d], 1e-4), 1 - 1e-4)
        a = F.when(F.col("c_case").isNull(), F.lit(0.0)).otherwise(
            F.lit(weights.agent_weight) * (F.col("c_case") * F.lit(math.log(psi))
                                           + (F.lit(1.0) - F.col("c_case")) * F.lit(math.log(1 - psi))))
        logits.append(F.lit(math.log(params.p_delta[d] + EPS)) + base[d] + a)
    _, lse = softmax_eps(logits)
    return cells.agg((F.sum(F.col("w_sum") * lse) / (F.sum("w_sum") + F.lit(EPS))).alias("avg_ll"))


PARAM_COLS = ("pi_env", "pi_agent", "theta_env_gui", "theta_env_code", "theta_env_noresp",
              "theta_agent_gui", "theta_agent_code", "theta_agent_noresp", "psi_env", "psi_agent")


def params_row(p: EMParams) -> list[float]:
    return [p.p_delta[0], p.p_delta[1], *p.theta[0], *p.theta[1], p.psi[0], p.psi[1]]


def params_frame(spark: SparkSession, p: EMParams, extra: dict | None = None) -> DataFrame:
    """One-row DataFrame of fitted parameters (plus e.g. n_iter, avg_ll)."""
    extra = extra or {}
    fields = [T.StructField(c, T.DoubleType()) for c in PARAM_COLS]
    vals = [float(x) for x in params_row(p)]
    for k, v in extra.items():
        fields.append(T.StructField(k, T.LongType() if isinstance(v, int) else T.DoubleType()))
        vals.append(v)
    return spark.createDataFrame([tuple(vals)], T.StructType(fields))


def save_params(spark: SparkSession, p: EMParams, path: str) -> None:
    """H6: params as one JSON document written through Spark (shared storage)."""
    spark.createDataFrame([(p.to_json(),)], "params string").coalesce(1) \
        .write.mode("overwrite").text(path)


def load_params(spark: SparkSession, path: str, causes: list[str] | None = None) -> EMParams:
    """H6: read params JSON written by ``save_params`` or by hand."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return EMParams.from_json(text, causes)
